"""Wordings of residue that were written without the list of exemplars and are not in it, and texts that are none: for measuring."""

RESIDUE = """
The requested URL was not found on this server.
Sorry, the page you are looking for doesn't exist.
A página que você procura não existe ou foi movida.
Lo sentimos, la página solicitada no está disponible.
Error 500. Something went wrong on our end.
Erro 503: serviço temporariamente indisponível.
Você não possui permissão para acessar este conteúdo.
You are not authorized to access this page.
No tiene autorización para acceder a este contenido.
JavaScript is disabled in your browser. Please enable it to continue.
Seu navegador está com o JavaScript desativado. Ative-o para continuar.
Este sitio requiere JavaScript para funcionar correctamente.
Please turn on JavaScript in your browser settings.
É necessário habilitar o JavaScript para visualizar o conteúdo.
Sua sessão expirou. Entre novamente.
Your session timed out. Please log in again.
Vaga expirada. Esta oportunidade já foi encerrada.
This job posting has expired.
Esta oferta de empleo ha caducado.
Lorem ipsum dolor sit amet, consectetur adipiscing elit, sed do eiusmod.
Vivamus lorem ipsum dolor sit amet.
{{job.title}} - {{company.name}}
Buscamos ${position} para nosso time
[INSERIR NOME DA EMPRESA]
[Insert company description here]
[Nome da cidade]
Insira aqui o título da vaga
Digite aqui a descrição da vaga
Add job description here
Escriba aquí el título del puesto
Texto de exemplo para a descrição
This is sample text
Teste teste
test test
bla bla bla
asdfasdf asdf
xxxxxxxx
TBD
To be defined by HR
A definir pelo RH
undefined
null
[object Object]
NaN
#VALUE!
Too many requests. Please try again later.
Muitas requisições. Tente novamente mais tarde.
Access to this page has been denied.
Acesso bloqueado. Verifique se você é humano.
Checking your browser before accessing the site.
Please complete the security check to access the site.
Confirme que você não é um robô.
Ocorreu um erro ao carregar a página. Tente novamente.
An error occurred while processing your request.
Se ha producido un error al procesar su solicitud.
Fatal error: Call to undefined function on line 12
Carregando...
Loading, please wait...
Aceite os cookies para continuar navegando.
This website uses cookies to ensure you get the best experience.
Faça o login para visualizar esta vaga.
Sign in to see this job.
"""

CLEAN = """
Atuar no tratamento de erros 500 e 503 das APIs da empresa.
Experiência com JavaScript e cookies de sessão.
Desenvolver telas de login e páginas de erro em React.
Conhecimento em templates Handlebars e variáveis de ambiente.
Garantir que a página de vagas não fique indisponível.
You will investigate access denied incidents in our cloud accounts.
Build custom 404 pages and improve page load.
Substituir textos lorem ipsum por conteúdo real nos protótipos.
Trabalhar com gestão de permissões e acesso negado no Active Directory.
Responsável por testes de carga e testes automatizados.
Vaga para analista de testes sênior em São Paulo.
Monitorar respostas 429 e limites de requisições.
Implementar verificação de robôs e captcha no cadastro.
Gestionar sesiones expiradas y permisos de usuario.
Crear plantillas de correo con variables para clientes.
Auxiliar no carregamento de caminhões e controle de estoque.
Dominar o ciclo de vida de sessões expiradas em OAuth.
A empresa oferece vale refeição e plano de saúde.
Sign in flows, password reset and session management with Node.
Buscamos alguém para a área de segurança de acesso.
"""
