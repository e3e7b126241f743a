"""Seed texts of the residue models: public stock wording of servers, browsers, site builders and blind texts.

Fixed values. They start the models; the corpus itself teaches the rest (``residue.wordings``).
No line of the test tables is among them; a test compares them.
"""

FILLER = """
Lorem ipsum dolor sit amet, consectetur adipiscing elit, sed do eiusmod tempor incididunt ut labore et dolore magna aliqua.
Ut enim ad minim veniam, quis nostrud exercitation ullamco laboris nisi ut aliquip ex ea commodo consequat.
Duis aute irure dolor in reprehenderit in voluptate velit esse cillum dolore eu fugiat nulla pariatur.
Excepteur sint occaecat cupidatat non proident, sunt in culpa qui officia deserunt mollit anim id est laborum.
Sed ut perspiciatis unde omnis iste natus error sit voluptatem accusantium doloremque laudantium, totam rem aperiam.
Nemo enim ipsam voluptatem quia voluptas sit aspernatur aut odit aut fugit, sed quia consequuntur magni dolores eos.
At vero eos et accusamus et iusto odio dignissimos ducimus qui blanditiis praesentium voluptatum deleniti atque corrupti.
Nam libero tempore, cum soluta nobis est eligendi optio cumque nihil impedit quo minus id quod maxime placeat facere possimus.
Vestibulum ante ipsum primis in faucibus orci luctus et ultrices posuere cubilia curae; pellentesque habitant morbi tristique.
Curabitur pretium tincidunt lacus, nulla gravida orci a odio, nullam varius turpis et commodo pharetra est eros bibendum elit.
Blah, blah, blah. Bla bla bla. Yada yada yada. Etaoin shrdlu.
asdfasdf asdf jkl; asdf qwerty qwertyuiop zxcvbnm hjkl fdsa aaaa bbbb cccc
xxx xxxx xxxxx xxx xxxx xx xxxxxxxx tktktk tk tk
foo bar baz qux quux foobar test test test testing 1 2 3
Far far away, behind the word mountains, far from the countries Vokalia and Consonantia, there live the blind texts.
Li Europan lingues es membres del sam familie. Lor separat existentie es un myth.
One morning, when Gregor Samsa woke from troubled dreams, he found himself transformed in his bed into a horrible vermin.
I'm a paragraph. Click here to add your own text and edit me. It's easy.
This is some text inside of a div block.
Click to edit this text. Double click here to edit. Type your paragraph here.
Use this area to describe one of your services. Describe your item here.
Insert your text here. Enter your text here. Put your copy in this box.
Write your own description here. Place your headline here. Write a caption here.
Replace this text with your own content. Edit or delete it, then start writing!
Hello world! This is your first post.
This is an example page. It's different from a blog post because it will stay in one place.
Just another site. Site tagline goes in this space.
Dummy text, to be filled in later. Placeholder paragraph, not for publication.
Sample copy for layout purposes only. The final wording will be supplied by the client.
FPO. For position only. Greeked text. Body copy to come.
TODO add a description. TODO: fill in the details. FIXME: missing text.
TBD. To be determined. To be announced. Content to follow. More text to come.
No description provided. Description not available yet. Enter a description for this item.
New page. Untitled document. Your title. Your subtitle.
[Insert paragraph] [Insert description] [Text to be supplied]
(write the introduction) (add the body of the article)
Dies ist ein Typoblindtext. An ihm kann man sehen, ob alle Buchstaben da sind und wie sie aussehen.
Weit hinten, hinter den Wortbergen, fern der Länder Vokalien und Konsonantien leben die Blindtexte.
Fügen Sie hier Ihren Text ein. Klicken Sie hier, um den Text zu bearbeiten. Mustertext. Beispielinhalt folgt noch.
Ajoutez votre texte à cet endroit. Cliquez ici pour modifier ce texte. Texte d'exemple, contenu à venir.
Añada su texto en este lugar. Haga clic para editar este párrafo. Texto de ejemplo, contenido por definir.
Adicione o seu texto aqui. Clique para editar este parágrafo. Texto de exemplo, conteúdo em breve.
Inserisci qui il tuo testo. Testo segnaposto. Contenuto in arrivo.
Рыбный текст. Далеко-далеко за словесными горами в стране гласных и согласных живут рыбные тексты.
Введите текст. Вставьте сюда описание. Временный текст, содержание появится позже.
これはダミーテキストです。ここにテキストを入力してください。サンプル文章です。内容は後で差し替えます。
请在此处输入文字。示例文本,内容待补充。这里是占位文字。
"""

NOTICE = """
The requested URL was not found on this server. Additionally, a 404 Not Found error was encountered.
The resource you are looking for has been removed, had its name changed, or is temporarily unavailable.
Sorry, but the page you were trying to view does not exist. It looks like this was the result of a mistyped address or an out-of-date link.
That page can't be found. It looks like nothing was found at this location. Maybe try a search?
This page doesn't exist. Return to the homepage. Check the spelling of the address and try once more.
The document has moved. This content is no longer available. This item was deleted by its owner.
We can't seem to find the page you're looking for. The link you followed may be broken.
Not Found. File not found. No such page. Invalid URL. Gone.
Forbidden. You don't have permission to access this resource on this server.
You are not authorized to view this page. Unauthorized. Authentication is required to see this content.
This server could not verify that you are authorized to access the document requested.
You must be logged in to view this content. Please log in to continue. Please sign in with your account.
Your session has timed out. For your security you have been logged off. Please log in again.
The token has expired. Your login is no longer valid.
Bad Request. Your browser sent a request that this server could not understand.
The server encountered an internal error or misconfiguration and was unable to complete your request.
A server error occurred. Please contact the administrator.
The website encountered an unexpected error. Please try again later.
There has been a critical error on this website. Please check your site admin email inbox for instructions.
Application error: a client-side exception has occurred. See the browser console for more information.
Something went wrong. Sorry about that, our team has been notified. Refresh the page or try again in a moment.
We're having trouble loading this page. An unknown error occurred while we were handling your request. Error code 1020.
Fatal error: Uncaught exception. Warning: mysql_connect(): Access denied for user. Stack trace follows.
Error connecting to database server. Database connection failed. Too many connections.
The service is unavailable. The server is temporarily unable to service your request due to maintenance downtime or capacity problems.
Briefly unavailable for scheduled maintenance. Check back in a minute. We are currently upgrading the system.
Sorry for the inconvenience, we're performing some maintenance at the moment. We'll be back online soon.
The proxy server received an invalid response from an upstream server.
Gateway Time-out. The gateway did not receive a timely response from the upstream server or application.
Error 503 Backend fetch failed. Guru Meditation. The origin server is not reachable. Connection timed out.
This site can't be reached. The connection was reset. The server took too long to send data.
Rate limit exceeded. You have sent too many requests in a given amount of time. Please slow down and retry after a short wait.
Sorry, you have been blocked. You are unable to access this site. The action you just performed triggered the security solution.
Checking if the site connection is secure. Please complete the security check to access the website. Performance and security.
Please verify you are a human. Press and hold to confirm you are not a bot. I'm not a robot. Enter the characters you see below.
Automated access to this page was denied because we believe you are using automation tools to browse the website.
Ray ID. Incident number. Request ID. Trace ID. Support ID. Error reference.
This content is not available in your country. Your region is not supported.
Please enable JavaScript and cookies to continue. Please turn JavaScript on and reload the page.
You need to enable JavaScript to run this app.
We're sorry but this app doesn't work properly without JavaScript enabled. Please enable it to continue.
JavaScript is not available. We've detected that JavaScript is disabled in this browser. Please switch to a supported browser.
JavaScript is required. For full functionality of this site it is necessary to enable JavaScript.
This site requires JavaScript. It seems your browser does not support scripts or they are turned off. The content could not be displayed.
Loading, please wait... If the page does not load, make sure that scripts and cookies are permitted.
Your browser is out of date or not supported. Please upgrade to a modern browser to use this service.
An ad blocker may prevent this page from being shown. Disable it and refresh.
Diese Seite konnte nicht gefunden werden. Die gewünschte Adresse ist ungültig oder die Seite wurde gelöscht. Zur Startseite.
Es ist ein unerwarteter Fehler aufgetreten. Bitte versuchen Sie es später noch einmal. Serverfehler. Fehlernummer.
Sie haben keinen Zugriff auf diesen Bereich. Zugang verweigert. Bitte melden Sie sich an. Ihre Sitzung ist abgelaufen.
Wegen Wartungsarbeiten ist die Website zurzeit nicht erreichbar. Wir sind in Kürze wieder da.
JavaScript ist in Ihrem Browser deaktiviert. Für diese Website muss JavaScript eingeschaltet sein.
Cette page est introuvable ou a été supprimée. L'adresse demandée n'existe pas. Retour à l'accueil.
Une erreur inattendue s'est produite. Veuillez réessayer plus tard. Erreur interne du serveur. Accès interdit.
Votre session a expiré, veuillez vous reconnecter. Site en maintenance, nous serons bientôt de retour.
JavaScript est désactivé dans votre navigateur. Ce site nécessite JavaScript pour fonctionner correctement.
La página que busca no existe o ha sido eliminada. No se encuentra la página. Volver al inicio.
Ha ocurrido un error inesperado. Inténtelo de nuevo más tarde. Error interno del servidor. No tiene permiso para ver este recurso.
Su sesión ha caducado. Sitio en mantenimiento, volveremos pronto. Acceso prohibido.
Es necesario habilitar JavaScript en el navegador para ver este sitio. JavaScript está desactivado.
A página que procura não existe ou foi removida. Ocorreu um erro inesperado. Tente novamente mais tarde.
É necessário ativar o JavaScript no navegador para usar este site. Acesso negado. A sua sessão expirou.
La pagina richiesta non è stata trovata. Si è verificato un errore. Riprova più tardi. Abilita JavaScript nel browser.
Такой страницы не существует или она была удалена. Вернуться на главную. Произошла непредвиденная ошибка, попробуйте позже.
Внутренняя ошибка сервера. Доступ запрещён. Для работы сайта необходимо включить JavaScript в браузере.
指定されたページは存在しません。URLをご確認ください。ページは削除されたか、名前が変更されています。トップページへ戻る。
エラーが発生しました。しばらくしてからもう一度お試しください。アクセス権限がありません。ただいまメンテナンス中です。
JavaScriptが無効になっています。ブラウザの設定でJavaScriptを有効にしてください。
您访问的页面不存在或已被删除。返回首页。服务器发生错误,请稍后再试。请启用 JavaScript 后重试。没有权限访问。
"""

FURNITURE = """
Skip to content. Skip to navigation. Skip to footer. Back to top. Table of contents. On this page.
Home. About. Contact. Careers. Press. Blog. Support. Search. Menu. Log in. Sign up. Register.
Copyright, all rights reserved. Terms of service. Privacy policy. Cookie policy. Imprint. Legal notice. Accessibility statement.
We use cookies to improve your experience. By continuing to browse you agree to our use of cookies. Manage preferences.
Did you find this article helpful? Give feedback. Rate this page. Report an issue with this article. Suggest an edit.
Last updated. Last modified. Published by the editorial team. Written by. Reviewed by. Estimated reading time in minutes.
Share on social media. Tweet this. Copy link. Print this page. Email this to a friend. Subscribe to our mailing list.
Related articles. Recommended for you. Next article. Previous article. Read more. Show comments. Leave a reply.
Sponsored content. Our partners. Download our mobile app. Join our community. Ask a question in the forum.
This documentation is provided without warranty of any kind. Licensed under a Creative Commons licence.
Alle Rechte vorbehalten. Impressum. Datenschutz. Angaben ohne Garantie. Tous droits. Mentions légales. Todos los derechos reservados. Aviso legal.
"""
